"""Physical-plan assertions on the headline queries."""
import pytest

import __spark_entry__ as entry
from tests.conftest import SF001

BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["forecast_bands", "asof_fallback", "feature_table",
                                  "merge_sources", "time_split_rows", "top_markets",
                                  "regression_metrics", "iqr_cap", "one_hot_requests"])
def test_no_cartesian_or_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF001))
    for bad in BAD:
        assert bad not in plan, f"{name}: {bad}"


def test_python_only_in_arima(spark):
    plan = _plan(entry.queries()["arima_series_metrics"](spark, SF001))
    assert "FlatMapGroupsInPandas" in plan


def test_scan_is_pruned(spark):
    import re
    plan = _plan(entry.queries()["top_markets"](spark, SF001))
    scans = [m for m in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "l_" in m]
    # top markets needs market + price only: the lineitem scan reads 4 of 11 columns
    assert scans and all("l_shipdate" not in s and "l_returnflag" not in s for s in scans)
    assert "PushedFilters: [IsNotNull(l_extendedprice)" in plan


def _moves(plan):
    """Shuffles of a plan, broadcasts not counted."""
    return [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


def test_time_split_moves_no_row(spark):
    assert _moves(_plan(entry.queries()["time_split_rows"](spark, SF001))) == []


def test_series_windows_move_rows_once(spark):
    """Long series or none: the list of chunk dates is broadcast here, and only the window shuffles."""
    from pricecast.operators.features import add_series_windows
    from pricecast.sources import tables as tb
    obs = tb.price_obs(spark, SF001)
    for size in (50, 2_000_000):
        out = add_series_windows(obs, ["commodity"], ["arrival_date", *tb.TIEBREAK], "modal_price", chunk_rows=size)
        assert len(_moves(_plan(out))) == 1
