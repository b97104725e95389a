"""Registered serving queries: J2 ladder, M1b flagship bands, W13, N1."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricecast.functions.keys import norm_key
from pricecast.operators.lookup import asof_fallback, latest_per_key
from pricecast.plans.catalog import finish, register
from pricecast.plans.forecast import forecast_bands
from pricecast.plans.oracle import norm_sql, r4, with_fixtures
from pricecast.sources import tables as tb

# (k1, k2, k3) is unique per (series, date); market completes it across series.
SERVE_TIEBREAK = ["k1", "k2", "k3", "market"]
PAYLOAD = ["min_price", "max_price", "arrival_quantity"]

_HIST = f"""hist AS (
  SELECT {norm_sql("coalesce(CAST(state AS VARCHAR), 'nan')")} AS s,
         {norm_sql("coalesce(CAST(market AS VARCHAR), 'nan')")} AS m,
         {norm_sql("coalesce(CAST(commodity AS VARCHAR), 'nan')")} AS c,
         arrival_date AS d, k1, k2, k3, min_price, max_price, arrival_quantity, modal_price
  FROM price_obs WHERE arrival_date IS NOT NULL)"""

REQ_CTE = f"""req AS (
  SELECT request_id, state, market, commodity, arrival_date,
         {norm_sql("coalesce(state, '')")} AS key_state,
         {norm_sql("coalesce(market, '')")} AS key_market,
         {norm_sql("coalesce(commodity, '')")} AS key_commodity
  FROM requests)"""

CANDIDATES_CTE = """cand AS (
  SELECT r.request_id, 0 AS lvl, 'exact' AS name, h.* FROM req r JOIN hist h
    ON h.s = r.key_state AND h.m = r.key_market AND h.c = r.key_commodity AND h.d <= r.arrival_date
  UNION ALL
  SELECT r.request_id, 1, 'state_commodity', h.* FROM req r JOIN hist h
    ON h.s = r.key_state AND h.c = r.key_commodity AND h.d <= r.arrival_date
  UNION ALL
  SELECT r.request_id, 2, 'commodity_only', h.* FROM req r JOIN hist h
    ON h.c = r.key_commodity AND h.d <= r.arrival_date
  UNION ALL
  SELECT r.request_id, 5, 'commodity_only', h.* FROM req r JOIN hist h
    ON h.c = r.key_commodity),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id
                                 ORDER BY lvl, d DESC, k1 DESC, k2 DESC, k3 DESC, m DESC) AS rn
    FROM cand) WHERE rn = 1)"""

_MATCHED = """matched AS (
  SELECT r.*, coalesce(b.name, 'date_only') AS fallback_level, b.d AS matched_date,
         b.min_price, b.max_price, b.arrival_quantity, b.k1, b.k2, b.k3
  FROM req r LEFT JOIN best b ON b.request_id = r.request_id)"""


_ASOF_SQL = with_fixtures(_HIST, REQ_CTE, CANDIDATES_CTE, _MATCHED, select=f"""
SELECT request_id, state, market, commodity, arrival_date, key_state, key_market, key_commodity,
       fallback_level, matched_date, {r4("min_price")} AS min_price, {r4("max_price")} AS max_price,
       {r4("arrival_quantity")} AS arrival_quantity, k1, CAST(k2 AS BIGINT) AS k2, k3,
       CAST(year(arrival_date) AS BIGINT) AS year, CAST(month(arrival_date) AS BIGINT) AS month,
       CAST(weekofyear(arrival_date) AS BIGINT) AS weekofyear,
       CAST(isodow(arrival_date) - 1 AS BIGINT) AS day_of_week,
       CAST(quarter(arrival_date) AS BIGINT) AS quarter,
       CAST(isodow(arrival_date) >= 6 AS BIGINT) AS is_weekend,
       {r4("sin(2 * pi() * month(arrival_date) / 12)")} AS month_sin,
       {r4("cos(2 * pi() * month(arrival_date) / 12)")} AS month_cos,
       {r4("sin(2 * pi() * (isodow(arrival_date) - 1) / 7)")} AS dow_sin,
       {r4("cos(2 * pi() * (isodow(arrival_date) - 1) / 7)")} AS dow_cos
FROM matched""")


@register("asof_fallback", _ASOF_SQL)
def q_asof(spark, sf_dir):
    """J2 + N1 + N2/N3: every request matched through the fallback ladder."""
    out = asof_fallback(tb.requests(spark, sf_dir), tb.price_obs(spark, sf_dir),
                        PAYLOAD, SERVE_TIEBREAK)
    return finish(out.drop("market_1") if "market_1" in out.columns else out)


_ASOF_REPEATED_SQL = _ASOF_SQL.replace("SELECT request_id, state, market, commodity, arrival_date, key_state, key_market, key_commodity,\n       fallback_level", """
SELECT CASE WHEN request_id % 13 = 0 THEN NULL ELSE request_id % 100 END AS request_id,
       state, market, commodity, arrival_date, key_state, key_market, key_commodity, fallback_level""")


@register("asof_fallback_repeated_ids", _ASOF_REPEATED_SQL)
def q_asof_repeated(spark, sf_dir):
    """J2 with request ids that repeat or are null: one answer per request row all the same."""
    rid = F.col("request_id")
    req = tb.requests(spark, sf_dir).withColumn("request_id", F.when(rid % 13 != 0, rid % 100))
    return finish(asof_fallback(req, tb.price_obs(spark, sf_dir), PAYLOAD, SERVE_TIEBREAK))


_BANDS = """bands AS (
  SELECT 'exact' AS bl, s AS bs, m AS bm, c AS bc, quantile_cont(modal_price, 0.1) AS q10,
         quantile_cont(modal_price, 0.5) AS q50, quantile_cont(modal_price, 0.9) AS q90
  FROM hist WHERE modal_price IS NOT NULL GROUP BY s, m, c
  UNION ALL
  SELECT 'state_commodity', s, '', c, quantile_cont(modal_price, 0.1),
         quantile_cont(modal_price, 0.5), quantile_cont(modal_price, 0.9)
  FROM hist WHERE modal_price IS NOT NULL GROUP BY s, c
  UNION ALL
  SELECT 'commodity_only', '', '', c, quantile_cont(modal_price, 0.1),
         quantile_cont(modal_price, 0.5), quantile_cont(modal_price, 0.9)
  FROM hist WHERE modal_price IS NOT NULL GROUP BY c
  UNION ALL
  SELECT 'date_only', '', '', '', quantile_cont(modal_price, 0.1),
         quantile_cont(modal_price, 0.5), quantile_cont(modal_price, 0.9)
  FROM hist WHERE modal_price IS NOT NULL),
scored AS (
  SELECT m.*, b.q10, b.q50, b.q90 FROM matched m LEFT JOIN bands b
  ON b.bl = m.fallback_level
 AND b.bs = CASE WHEN m.fallback_level IN ('exact', 'state_commodity') THEN m.key_state ELSE '' END
 AND b.bm = CASE WHEN m.fallback_level = 'exact' THEN m.key_market ELSE '' END
 AND b.bc = CASE WHEN m.fallback_level IN ('exact', 'state_commodity', 'commodity_only')
                 THEN m.key_commodity ELSE '' END)"""

_FLAGSHIP_SQL = with_fixtures(_HIST, REQ_CTE, CANDIDATES_CTE, _MATCHED, _BANDS, select=f"""
SELECT request_id, state, market, commodity, arrival_date, fallback_level, matched_date,
       {r4("q10")} AS q10, {r4("q50")} AS q50, {r4("q90")} AS q90,
       {r4("q90 - q10")} AS interval_width,
       CAST(CASE fallback_level WHEN 'exact' THEN 90 WHEN 'latest_in_series' THEN 70
            WHEN 'state_commodity' THEN 55 WHEN 'commodity_only' THEN 40 ELSE 20 END AS BIGINT)
         AS confidence_pct,
       CASE fallback_level WHEN 'exact' THEN 'Exact match'
            WHEN 'state_commodity' THEN 'State + commodity fallback'
            WHEN 'commodity_only' THEN 'Commodity fallback' ELSE 'Date-only' END AS fallback_label,
       CASE fallback_level WHEN 'exact' THEN 'good' WHEN 'state_commodity' THEN 'warn'
            WHEN 'commodity_only' THEN 'warn2' ELSE 'bad' END AS fallback_tone
FROM scored""")


@register("forecast_bands", _FLAGSHIP_SQL)
def q_forecast_bands(spark, sf_dir):
    """Flagship: M1b bands + P9 width + P10 confidence + P11 label for all requests."""
    out = forecast_bands(tb.requests(spark, sf_dir), tb.price_obs(spark, sf_dir),
                         SERVE_TIEBREAK, PAYLOAD)
    return finish(out.select("request_id", "state", "market", "commodity", "arrival_date",
                             "fallback_level", "matched_date", "q10", "q50", "q90",
                             "interval_width", "confidence_pct", "fallback_label",
                             "fallback_tone"))


@register("fallback_level_counts", with_fixtures(_HIST, REQ_CTE, CANDIDATES_CTE, _MATCHED, select="""
SELECT fallback_level, (matched_date IS NOT NULL AND matched_date > arrival_date) AS undated,
       count(*) AS n_requests
FROM matched GROUP BY ALL"""))
def q_level_counts(spark, sf_dir):
    """Ladder outcome counts (FIXTURES.md table): level x undated hit."""
    m = asof_fallback(tb.requests(spark, sf_dir), tb.price_obs(spark, sf_dir),
                      PAYLOAD, SERVE_TIEBREAK)
    return (m.groupBy("fallback_level",
                      (F.col("matched_date").isNotNull()
                       & (F.col("matched_date") > F.col("arrival_date"))).alias("undated"))
             .agg(F.count(F.lit(1)).alias("n_requests")))


@register("latest_per_series", with_fixtures(select=f"""
SELECT commodity, state, district, market, arrival_date, k1, CAST(k2 AS BIGINT) AS k2, k3,
       {r4("modal_price")} AS modal_price
FROM (SELECT *, row_number() OVER (PARTITION BY commodity, state, district, market
                                   ORDER BY arrival_date DESC, k1 DESC, k2 DESC, k3 DESC) AS rn
      FROM price_obs) WHERE rn = 1"""))
def q_latest(spark, sf_dir):
    """The latest observation of every series."""
    obs = tb.price_obs(spark, sf_dir).select(*tb.SERIES_KEY, "arrival_date", *tb.TIEBREAK,
                                             "modal_price")
    return finish(latest_per_key(obs, tb.SERIES_KEY, ["arrival_date", *tb.TIEBREAK]))


@register("normalized_request_keys", with_fixtures(select=f"""
SELECT request_id, {norm_sql("coalesce(state, '')")} AS key_state,
       {norm_sql("coalesce(market, '')")} AS key_market,
       {norm_sql("coalesce(commodity, '')")} AS key_commodity FROM requests"""))
def q_norm_keys(spark, sf_dir):
    """N1 over every request."""
    r = tb.requests(spark, sf_dir)
    return r.select("request_id", norm_key("state").alias("key_state"),
                    norm_key("market").alias("key_market"),
                    norm_key("commodity").alias("key_commodity"))
