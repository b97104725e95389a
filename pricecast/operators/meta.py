"""Metadata and summary aggregations.

All are hash aggregates with map-side partial aggregation, so a hot key is
combined per task before the shuffle and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def filter_eq(df: DataFrame, **kv) -> DataFrame:
    """optional equality filters (``None`` / empty skips); pushed to the scan."""
    for k, v in kv.items():
        if v:
            df = df.where(F.col(k) == F.lit(v))
    return df


def distinct_values(df: DataFrame, col: str, **filters) -> DataFrame:
    """A1: sorted distinct non-null values of ``col`` (empty if the column is absent)."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame([], f"{col} string")
    out = filter_eq(df, **filters).select(col).dropna().distinct()
    return out.orderBy(col)


def top_markets(df: DataFrame, state: str | None = None, commodity: str | None = None,
                k: int = 10, arrivals_col: str = "arrivals",
                price_col: str = "modal_price") -> DataFrame:
    """A2: markets ranked by activity.

    activity = sum(arrivals) when the arrivals column exists and the filtered
    set holds at least one non-null arrival, else the row count. The plan is
    a pruned scan with pushed filters, partial/final hash aggregate and a
    top-k (TakeOrderedAndProject).
    """
    if int(k) < 1:
        raise ValueError("k must be at least 1")
    df = df.dropna(subset=[c for c in ("state", "market", "commodity") if c in df.columns])
    df = filter_eq(df, state=state, commodity=commodity)
    if price_col in df.columns:
        df = df.where(F.col(price_col).isNotNull())
    has_arr = arrivals_col in df.columns
    aggs = [F.avg(price_col).alias("avg_price"), F.count(F.lit(1)).alias("records")]
    if has_arr:
        aggs += [F.coalesce(F.sum(arrivals_col), F.lit(0.0)).alias("_arr_sum"),
                 F.count(arrivals_col).alias("_arr_n")]
    g = df.groupBy("market").agg(*aggs)
    # "any non-null arrival in the filtered set": a presence probe that stops
    # at the first matching row
    if has_arr and df.where(F.col(arrivals_col).isNotNull()).limit(1).count() > 0:
        g = g.withColumn("activity", F.col("_arr_sum")).drop("_arr_sum", "_arr_n")
    elif has_arr:
        g = g.withColumn("activity", F.col("records").cast("double")).drop("_arr_sum", "_arr_n")
    else:
        g = g.withColumn("activity", F.col("records").cast("double"))
    return (g.orderBy(F.desc("activity"), F.asc("market")).limit(int(k))
             .select("market", "activity", F.bround("avg_price", 2).alias("avg_price"),
                     "records"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A3: records per value, descending (pandas drops null values)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("n_records"))
              .orderBy(F.desc("n_records"), F.asc(col)))


def price_trend(df: DataFrame, commodity: str | None = None,
                date_col: str = "arrival_date", price_col: str = "modal_price") -> DataFrame:
    """A4: daily mean price of one commodity (default: the most frequent one).

    The winner is a one-row table (top-1 of the value counts), so the
    semi-join broadcast has a proven size of one row.
    """
    if commodity is None:
        top = value_counts(df, "commodity").limit(1).select("commodity")
        df = df.join(F.broadcast(top), "commodity", "left_semi")
    else:
        df = df.where(F.col("commodity") == commodity)
    # mean from an exact decimal sum: independent of summation order
    exact_sum = F.sum(F.col(price_col).cast("decimal(38,8)")).cast("double")
    return (df.where(F.col(date_col).isNotNull()).groupBy(date_col).agg((exact_sum / F.count(price_col)).alias("avg_price"),
                                     F.count(F.lit(1)).alias("n_records"))
              .orderBy(date_col))


def top_markets_per_commodity(df: DataFrame, n: int = 2) -> DataFrame:
    """A5: the ``n`` markets with most rows per commodity.

    The ranking window runs over the grouped (commodity, market) table, so
    each window partition holds one commodity's markets, not its rows.
    """
    known = df.where(F.col("commodity").isNotNull() & F.col("market").isNotNull())
    g = known.groupBy("commodity", "market").agg(F.count(F.lit(1)).alias("n_records"))
    w = Window.partitionBy("commodity").orderBy(F.desc("n_records"), F.asc("market"))
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def split_summary(df: DataFrame, split_col: str = "split",
                  date_col: str = "arrival_date") -> DataFrame:
    """Rows and date range per split."""
    return (df.groupBy(split_col).agg(F.count(F.lit(1)).alias("rows"),
                                      F.min(date_col).alias("min_date"),
                                      F.max(date_col).alias("max_date")))


def audit_load(df: DataFrame, date_col: str = "arrival_date") -> DataFrame:
    """Row count and date range read back from a sink."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(date_col).alias("min_date"),
                  F.max(date_col).alias("max_date"))


def coverage_pct(df: DataFrame, col: str) -> DataFrame:
    """Share of non-null values in percent."""
    return df.agg((F.avg(F.col(col).isNotNull().cast("double")) * 100).alias("coverage_pct"))


__all__ = ["filter_eq", "distinct_values", "top_markets", "value_counts", "price_trend",
           "top_markets_per_commodity", "split_summary", "audit_load", "coverage_pct"]
