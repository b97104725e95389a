"""Driver contract: entry() runs, every query builds and runs at sf0.001."""
import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

FAST = ["top_markets", "asof_fallback", "feature_table", "time_split_summary", "category_index",
        "regression_metrics", "iqr_cap", "one_hot_requests", "sequence_windows", "arima_series_metrics"]


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"request_id", "fallback_level", "q10", "q50", "q90", "confidence_pct"} <= set(df.columns)


def test_every_query_has_callable_and_oracle_keys_subset():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


@pytest.mark.parametrize("name", FAST)
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF001)
    assert df.count() >= 0 and len(df.columns) > 0
