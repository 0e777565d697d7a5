"""Text queries against their reference SQL."""

import duckdb
import pytest
from tests.conftest import SMALL
from tidebook.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as from '{SMALL}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    assert sorted(map(tuple, ours[columns].to_numpy().tolist())) == sorted(map(tuple, theirs[columns].to_numpy().tolist()))
