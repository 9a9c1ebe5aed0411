"""Every registered query with SQL gives the rows that DuckDB gives for it on the smallest tables."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from conftest import LARGER, SF

from admitlake.plans import QUERIES, SQL


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    def plain(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v + 0.0)
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, duck):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["clean_text", "valid_content", "dup_keep_best", "compare_schools", "snippets", "features_fit", "dense_topk", "bm25_topk", "ema_latency"])
def test_same_rows_as_sql_on_larger_tables(name, spark, larger_duck):
    got, want = QUERIES[name](spark, LARGER).toPandas(), larger_duck.sql(SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(name, spark):
    assert QUERIES[name](spark, SF).columns


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
