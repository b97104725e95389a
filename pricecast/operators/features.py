"""Leakage-safe time-series and context features.

Series windows (lags, rolling) run through ``order.chunked``, so a long
series is cut into chunks with a halo instead of landing in one task; the
same window partitioning serves every lag and rolling column (one shuffle).
Per-group statistics (market frequency, z-score) are hash aggregates with
partial aggregation, joined back, rather than whole-partition windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricecast.functions.calendar import calendar_columns
from pricecast.functions.numeric import log1p0
from pricecast.operators.order import CHUNK_ROWS, chunked, finish_chunked
from pricecast.session import checkpoint

DATE = "arrival_date"


def _all_not_null(keys: list[str]) -> Column:
    c = F.lit(True)
    for k in keys:
        c = c & F.col(k).isNotNull()
    return c


def add_series_windows(df: DataFrame, key: list[str], order: list[str], col: str,
                       lags: tuple[int, ...] = (1, 3, 7), roll: int | None = 7,
                       roll_fns: tuple[str, ...] = ("mean", "std"),
                       lag_prefix: str | None = None, roll_prefix: str | None = None,
                       chunk_rows: int = CHUNK_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Row lags and a shifted rolling window of ``col`` per series.

    * ``{prefix}_lag_{n}``: value ``n`` rows back in the series;
    * ``{prefix}_roll_mean_{r}`` / ``_roll_std_{r}``: mean / sample std of the
      ``r`` rows before the current one, null unless all ``r`` are non-null.
    Rows whose series key has a null get nulls (pandas drops null groups).
    """
    lag_prefix = lag_prefix or col.split("_")[0]
    roll_prefix = roll_prefix or lag_prefix
    halo = max([*lags, roll or 0])
    frame, parts = chunked(df, key, order, halo, chunk_rows=chunk_rows, counted=counted)
    w = Window.partitionBy(*parts).orderBy(*order)
    ok = _all_not_null(key)
    cols: dict[str, Column] = {}
    for n in lags:
        cols[f"{lag_prefix}_lag_{n}"] = F.when(ok, F.lag(col, n).over(w))
    if roll:
        wf = w.rowsBetween(-roll, -1)
        full = F.count(col).over(wf) == roll
        if "mean" in roll_fns:
            cols[f"{roll_prefix}_roll_mean_{roll}"] = F.when(ok & full, F.avg(col).over(wf))
        if "std" in roll_fns:
            cols[f"{roll_prefix}_roll_std_{roll}"] = F.when(ok & full, F.stddev_samp(col).over(wf))
    return finish_chunked(frame.withColumns(cols))


def add_group_count(df: DataFrame, by: str, count_col: str = DATE,
                    out: str | None = None) -> DataFrame:
    """Rows with non-null ``count_col`` per ``by`` value; null key -> null."""
    out = out or f"{by}_freq"
    return _attach_stats(df, [([by], {out: F.count(count_col)})])


def add_group_zscore(df: DataFrame, key: list[str], col: str, out: str,
                     eps: float = 1e-9) -> DataFrame:
    """(x - mean) / (sample std + eps) within ``key``; single-row groups -> null."""
    return _zscore(_attach_stats(df, [(key, _z_stats(col))]), col, out, eps)


def _z_stats(col: str) -> dict[str, Column]:
    return {"_z_mean": F.avg(col), "_z_std": F.stddev_samp(col)}


def _zscore(df: DataFrame, col: str, out: str, eps: float = 1e-9) -> DataFrame:
    return (df.withColumn(out, (F.col(col) - F.col("_z_mean")) / (F.col("_z_std") + F.lit(eps)))
              .drop("_z_mean", "_z_std"))


def _attach_stats(df: DataFrame, groups: list[tuple[list[str], dict[str, Column]]],
                  counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the statistics of several groupings, each a (key, aggregates) pair, joined on.

    All groupings are aggregated in one pass (grouping sets, partial aggregates
    first) and written as one small table. Its size is then known before any
    row of ``df`` is moved, so it is broadcast unless it is large; a fact table
    is not shuffled on a key of few values. Null keys get nulls. ``counted`` is
    a frame with the same keys and aggregated columns, cheaper than ``df``.
    """
    base = df if counted is None else counted
    every = list(dict.fromkeys(k for key, _ in groups for k in key))
    sets = [[F.col(k) for k in key] for key, _ in groups]
    grouped = base.groupingSets(sets, *[F.col(k) for k in every])
    stats = checkpoint(grouped.agg(F.grouping_id().alias("_gid"), *[a.alias(n) for _, aggs in groups for n, a in aggs.items()]))
    bit = {k: 1 << (len(every) - 1 - i) for i, k in enumerate(every)}
    for key, aggs in groups:
        gid = sum(bit[k] for k in every if k not in key)
        g = stats.where(F.col("_gid") == gid).where(_all_not_null(key)).select(*key, *aggs)
        df = df.join(g, key, "left")
    return df


def add_lag_by(df: DataFrame, key: list[str], order: list[str], col: str, out: str,
               n: int = 1, bucket: list[str] | None = None, chunk_rows: int = CHUNK_ROWS,
               counted: DataFrame | None = None) -> DataFrame:
    """Lag of ``col`` within ``key`` under an arbitrary row order
    (the reference's rain lag crosses series inside a district)."""
    frame, parts = chunked(df, key, order, n, bucket, chunk_rows, counted)
    w = Window.partitionBy(*parts).orderBy(*order)
    return finish_chunked(frame.withColumn(out, F.when(_all_not_null(key),
                                                       F.lag(col, n).over(w))))


def weather_interactions(df: DataFrame) -> DataFrame:
    """Temperature range and temperature x humidity, only if columns exist."""
    cols = {}
    if {"t2m_max", "t2m_min"} <= set(df.columns):
        cols["temp_range"] = F.col("t2m_max") - F.col("t2m_min")
    if {"t2m", "rh2m"} <= set(df.columns):
        cols["temp_x_humidity"] = F.col("t2m") * F.col("rh2m")
    return df.withColumns(cols) if cols else df


def feature_table(df: DataFrame, series_key: list[str], tiebreak: list[str],
                  price_col: str = "modal_price", rain_by_date: bool = False,
                  weather: DataFrame | None = None, weather_key: tuple[str, ...] = ("district", DATE)) -> DataFrame:
    """The feature stage: calendar, cyclical, market frequency, arrivals,
    price lags/rolling, weather interactions and rain lag; rows without a
    7-row lag are dropped.

    The rows move twice, once per window, and the columns that need no window
    are added afterwards: what a window adds or a date tells is not moved.
    ``weather`` (one row per ``weather_key``, small enough to be broadcast as a
    rule) is joined here instead of by the caller, so that of its columns only
    the rain is moved.
    """
    df = df.where(F.col(DATE).isNotNull())
    obs = df      # the stages below keep its rows, so series are counted on it
    columns = set(df.columns) | set(weather.columns if weather is not None else ())
    rain = "prectotcorr" in columns
    if weather is not None and rain:
        df = df.join(weather.select(*weather_key, "prectotcorr"), list(weather_key), "left")
    if rain:
        lead = [DATE] if rain_by_date else ["commodity", "market", DATE]
        # counted by the leading columns without the date: one count per series, not per row
        df = add_lag_by(df, ["state", "district"], [*lead, *tiebreak], "prectotcorr", "rain_lag_1",
                        bucket=lead[:-1] or lead, counted=obs)
    order = [DATE, *tiebreak]
    df = add_series_windows(df, series_key, order, price_col, lags=(1, 3, 7), roll=7,
                            lag_prefix="modal", roll_prefix="modal", counted=obs)
    df = df.where(F.col("modal_lag_7").isNotNull())
    cal = calendar_columns(DATE)
    df = df.withColumns({k: cal[k] for k in ("month", "day_of_week", "weekofyear",
                                             "month_sin", "month_cos", "dow_sin", "dow_cos")})
    stats = [(["market"], {"market_freq": F.count(DATE)})]
    if "arrival_quantity" in df.columns:
        df = df.withColumn("arrival_qty_log1p", log1p0("arrival_quantity"))
        stats.append((["commodity", "state"], _z_stats("arrival_quantity")))
    df = _attach_stats(df, stats, counted=obs)
    if "arrival_quantity" in df.columns:
        df = _zscore(df, "arrival_quantity", "arrival_qty_z")
    if weather is not None:
        df = df.join(weather.drop("prectotcorr"), list(weather_key), "left")
    return weather_interactions(df)


def top_impacts(df: DataFrame, id_cols: list[str], feature_cols: list[str], k: int = 5,
                impact_name: str = "impact") -> DataFrame:
    """Per row, the ``k`` features with the largest absolute impact and a
    bar width = |impact| / max(max |impact| of the row's top k, 1) * 100.

    The window partitions are single rows' feature lists (bounded by the
    feature count), never a data key.
    """
    long = df.unpivot(id_cols, feature_cols, "feature", impact_name)
    w = Window.partitionBy(*id_cols).orderBy(F.desc(F.abs(impact_name)), F.asc("feature"))
    ranked = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    wmax = Window.partitionBy(*id_cols)
    top = F.greatest(F.max(F.abs(impact_name)).over(wmax), F.lit(1.0))
    return ranked.withColumn("width_pct", F.abs(impact_name) / top * 100)
