"""Registered queries over observations with missing keys, dates and prices.

The tables hold no nulls, so they are put in by fixed expressions of the row
numbers, the same on both sides. Grouped frames drop rows with a null key:
such a row belongs to no series, gets no lag or statistic and opens no group.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricecast.operators import clean, encode, features, meta, sequence
from pricecast.operators.join import merge_sources
from pricecast.plans.catalog import finish, register
from pricecast.plans.oracle import r4, with_fixtures
from pricecast.sources import tables as tb

# One row in so many, by order number, lacks the column.
EVERY = {"market": 17, "commodity": 19, "state": 29, "arrival_date": 23}
ROW = ["k1", "k2", "k3"]
ROW_SQL = "k1, CAST(k2 AS BIGINT) AS k2, k3"

OBS_NULLS = "obs_nulls AS (\n  SELECT * REPLACE (" + ", ".join(
    [f"CASE WHEN k1 % {n} <> 0 THEN {c} END AS {c}" for c, n in EVERY.items()]
    + ["CASE WHEN k2 <> 3 THEN modal_price END AS modal_price"]) + ") FROM price_obs)"

_SERIES = "PARTITION BY commodity, state, district, market ORDER BY arrival_date, k1, k2, k3"
_KNOWN = "commodity IS NOT NULL AND state IS NOT NULL AND market IS NOT NULL"


def obs_nulls(spark, sf_dir):
    obs = tb.price_obs(spark, sf_dir)
    gaps = {c: F.when(F.col("k1") % n != 0, F.col(c)) for c, n in EVERY.items()}
    return obs.withColumns({**gaps, "modal_price": F.when(F.col("k2") != 3, F.col("modal_price"))})


def _dated(spark, sf_dir):
    return obs_nulls(spark, sf_dir).where(F.col("arrival_date").isNotNull())


@register("series_features_nulls", with_fixtures(OBS_NULLS, select=f"""
SELECT {ROW_SQL}, CASE WHEN market IS NOT NULL THEN count(arrival_date) OVER (PARTITION BY market) END AS market_freq,
       {r4('''CASE WHEN commodity IS NOT NULL AND state IS NOT NULL THEN
              (arrival_quantity - avg(arrival_quantity) OVER (PARTITION BY commodity, state))
              / (stddev_samp(arrival_quantity) OVER (PARTITION BY commodity, state) + 1e-9) END''')} AS qty_z,
       {r4(f"CASE WHEN {_KNOWN} THEN lag(modal_price, 1) OVER ({_SERIES}) END")} AS modal_lag_1,
       {r4(f'''CASE WHEN {_KNOWN} AND count(modal_price) OVER ({_SERIES} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
               THEN avg(modal_price) OVER ({_SERIES} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END''')} AS modal_roll_mean_3
FROM obs_nulls WHERE arrival_date IS NOT NULL"""))
def q_features(spark, sf_dir):
    """Null keys get nulls; a rolling mean needs all its prices."""
    df = _dated(spark, sf_dir)
    df = features.add_group_count(df, "market")
    df = features.add_group_zscore(df, ["commodity", "state"], "arrival_quantity", "qty_z")
    df = features.add_series_windows(df, tb.SERIES_KEY, ["arrival_date", *ROW], "modal_price", lags=(1,), roll=3,
                                     roll_fns=("mean",), counted=_dated(spark, sf_dir))
    return finish(df.select(*ROW, "market_freq", "qty_z", "modal_lag_1", "modal_roll_mean_3"))


@register("ffill_nulls", with_fixtures(OBS_NULLS, select=f"""
SELECT {ROW_SQL}, {r4(f'''CASE WHEN {_KNOWN} THEN last_value(modal_price IGNORE NULLS) OVER (
       {_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END''')} AS modal_price
FROM obs_nulls WHERE arrival_date IS NOT NULL"""))
def q_ffill(spark, sf_dir):
    """Nothing is filled, and nothing kept, outside a series."""
    out = clean.ffill(_dated(spark, sf_dir), tb.SERIES_KEY, ["arrival_date", *ROW], "modal_price")
    return finish(out.select(*ROW, "modal_price"))


@register("sequence_windows_nulls", with_fixtures(OBS_NULLS, f"""s AS (
  SELECT *, count(*) OVER w AS k, list(CAST(arrival_quantity AS BIGINT)) OVER w AS seq FROM obs_nulls
  WHERE arrival_date IS NOT NULL AND {_KNOWN}
  WINDOW w AS (PARTITION BY commodity, state ORDER BY arrival_date, k1, k2, k3 ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""",
                                                  select=f"""
SELECT {ROW_SQL}, array_to_string(seq, ',') AS seq FROM s WHERE k = 5"""))
def q_sequences(spark, sf_dir):
    """Windows skip rows without a key."""
    df = _dated(spark, sf_dir).where(F.col("market").isNotNull())
    seq = sequence.sequences(df, ["commodity", "state"], ["arrival_date", *ROW], ["arrival_quantity"],
                             "modal_price", n=5)
    text = F.concat_ws(",", F.transform("seq", lambda x: x[0].cast("bigint").cast("string")))
    return finish(seq.select(*ROW, text.alias("seq")))


@register("log_delta_nulls", with_fixtures(OBS_NULLS, f"""s AS (
  SELECT *, ln(1 + modal_price) AS log_p, lag(ln(1 + modal_price), 1) OVER ({_SERIES}) AS log_p_lag1
  FROM obs_nulls WHERE arrival_date IS NOT NULL AND {_KNOWN})""", select=f"""
SELECT {ROW_SQL}, {r4("log_p - log_p_lag1")} AS delta FROM s
WHERE log_p IS NOT NULL AND log_p_lag1 IS NOT NULL"""))
def q_log_delta(spark, sf_dir):
    """A missing price ends two differences, a missing key starts none."""
    d = sequence.log_delta(_dated(spark, sf_dir), tb.SERIES_KEY, ["arrival_date", *ROW])
    return finish(d.select(*ROW, "delta"))


_SEASON_SQL = """season_nulls AS (
  SELECT state, market, commodity, arrival_date, count(*) AS n_reports FROM obs_nulls
  WHERE k2 <= 2 GROUP BY state, market, commodity, arrival_date)"""


@register("merge_sources_nulls", with_fixtures(OBS_NULLS, _SEASON_SQL, select=f"""
SELECT {ROW_SQL}, s.n_reports FROM obs_nulls o LEFT JOIN season_nulls s
  ON o.state IS NOT DISTINCT FROM s.state AND o.market IS NOT DISTINCT FROM s.market
 AND o.commodity IS NOT DISTINCT FROM s.commodity AND o.arrival_date IS NOT DISTINCT FROM s.arrival_date"""))
def q_merge(spark, sf_dir):
    """Null keys of both sides meet."""
    obs = obs_nulls(spark, sf_dir)
    key = ["state", "market", "commodity", "arrival_date"]
    right = obs.where(F.col("k2") <= 2).groupBy(*key).agg(F.count(F.lit(1)).alias("n_reports"))
    return finish(merge_sources(obs, right, key).select(*ROW, "n_reports"))


@register("price_trend_nulls", with_fixtures(OBS_NULLS, """top AS (
  SELECT commodity FROM obs_nulls WHERE commodity IS NOT NULL
  GROUP BY commodity ORDER BY count(*) DESC, commodity ASC LIMIT 1)""", select=f"""
SELECT arrival_date, {r4("CAST(sum(CAST(modal_price AS DECIMAL(38,8))) AS DOUBLE) / count(modal_price)")} AS avg_price,
       count(*) AS n_records
FROM obs_nulls WHERE arrival_date IS NOT NULL AND commodity IN (SELECT commodity FROM top) GROUP BY arrival_date"""))
def q_trend(spark, sf_dir):
    """A4: no group for missing dates, no vote for a missing commodity."""
    return finish(meta.price_trend(obs_nulls(spark, sf_dir)))


@register("top_markets_per_commodity_nulls", with_fixtures(OBS_NULLS, """g AS (
  SELECT commodity, market, count(*) AS n_records FROM obs_nulls
  WHERE commodity IS NOT NULL AND market IS NOT NULL GROUP BY commodity, market)""", select="""
SELECT commodity, market, n_records, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY n_records DESC, market) AS rank FROM g) WHERE rank <= 2"""))
def q_top(spark, sf_dir):
    """A5: a missing market takes no place."""
    return finish(meta.top_markets_per_commodity(obs_nulls(spark, sf_dir), n=2))


@register("category_index_nulls", with_fixtures(OBS_NULLS, """vals AS (
  SELECT DISTINCT 'state' AS "column", coalesce(state, 'nan') AS value FROM obs_nulls
  UNION ALL SELECT DISTINCT 'commodity', coalesce(commodity, 'nan') FROM obs_nulls)""", select="""
SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS idx FROM vals"""))
def q_category(spark, sf_dir):
    """A missing category is a category of its own."""
    return finish(encode.fit_category_index(obs_nulls(spark, sf_dir), ["state", "commodity"]))
