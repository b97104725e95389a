"""Registered evaluation queries: A7–A12, M9 (with U2), O6, O7, U1, E4/P8, W14.

The forecasts scored here are derived from the observations themselves:
persistence (previous price), the 7-row rolling mean, the weekly naive
(lag 7) and a lag/mean band that crosses whenever the last price is above
the recent mean - a real, data-driven quantile-crossing case.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricecast.operators import encode, features, metrics, schema, split
from pricecast.operators.lookup import latest_per_key
from pricecast.plans.catalog import finish, register
from pricecast.plans.feature_queries import ID, ID_SQL, ORDER, SPLIT_ORDER, _SPLIT_CTE
from pricecast.plans.oracle import norm_sql, r4, with_fixtures
from pricecast.sources import tables as tb

_FC = """fc AS (
  SELECT *,
    lag(modal_price, 1) OVER (PARTITION BY commodity, state, district, market
                              ORDER BY arrival_date, k1, k2, k3) AS p_last,
    lag(modal_price, 7) OVER (PARTITION BY commodity, state, district, market
                              ORDER BY arrival_date, k1, k2, k3) AS p_week,
    CASE WHEN count(modal_price) OVER (PARTITION BY commodity, state, district, market
              ORDER BY arrival_date, k1, k2, k3 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
         THEN avg(modal_price) OVER (PARTITION BY commodity, state, district, market
              ORDER BY arrival_date, k1, k2, k3 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS p_mean
  FROM price_obs)"""


def _forecasts(obs):
    fc = features.add_series_windows(obs, tb.SERIES_KEY, ORDER, "modal_price", lags=(1, 7),
                                     roll=7, roll_fns=("mean",), lag_prefix="p")
    return fc.withColumnsRenamed({"p_lag_1": "p_last", "p_lag_7": "p_week",
                                  "p_roll_mean_7": "p_mean"})


def _exact_mean_sql(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(38,8))) AS DOUBLE) / count({c})"


def _metric_sql(y: str, p: str, mape: str = "floor_one") -> str:
    den = (f"CASE WHEN abs({y}) < 1e-9 THEN 1.0 ELSE abs({y}) END" if mape == "floor_one"
           else f"greatest(abs({y}), 1e-6)")
    sse = f"sum(({y} - {p}) * ({y} - {p}))"
    sst = f"(var_pop({y}) * count(*))"
    r2 = f"CASE WHEN {sst} = 0 THEN (CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - {sse} / {sst} END"
    return (f"{r4(f'sqrt(avg(({y} - {p}) * ({y} - {p})))')} AS rmse, "
            f"{r4(f'avg(abs({y} - {p}))')} AS mae, "
            f"{r4(f'avg(abs(({y} - {p}) / ({den}))) * 100')} AS mape, {r4(r2)} AS r2")


@register("regression_metrics", with_fixtures(_FC, select=f"""
SELECT commodity, {_metric_sql("modal_price", "p_last")}, count(*) AS n
FROM fc WHERE modal_price IS NOT NULL AND p_last IS NOT NULL GROUP BY commodity"""))
def q_reg_metrics(spark, sf_dir):
    """A7 per commodity for the persistence forecast."""
    fc = _forecasts(tb.price_obs(spark, sf_dir))
    return finish(metrics.regression_metrics(fc, "modal_price", "p_last", by=["commodity"]))


@register("regression_metrics_clip", with_fixtures(_FC, select=f"""
SELECT {_metric_sql("modal_price", "p_mean", "clip")}, count(*) AS n
FROM fc WHERE modal_price IS NOT NULL AND p_mean IS NOT NULL"""))
def q_reg_metrics_clip(spark, sf_dir):
    """A7 (second MAPE variant, max(|y|, 1e-6)) for the rolling-mean forecast."""
    fc = _forecasts(tb.price_obs(spark, sf_dir))
    return finish(metrics.regression_metrics(fc, "modal_price", "p_mean", mape_mode="clip"))


@register("pinball_loss", with_fixtures(_FC, select=f"""
SELECT commodity, {r4("avg(greatest(0.9 * (modal_price - p_mean), (0.9 - 1) * (modal_price - p_mean)))")}
       AS pinball_q90
FROM fc WHERE modal_price IS NOT NULL AND p_mean IS NOT NULL GROUP BY commodity"""))
def q_pinball(spark, sf_dir):
    """A8 at q = 0.9 for the rolling-mean forecast, per commodity."""
    fc = _forecasts(tb.price_obs(spark, sf_dir))
    return finish(metrics.pinball_loss(fc, "modal_price", "p_mean", 0.9, by=["commodity"]))


@register("interval_quality", with_fixtures(_FC, select=f"""
SELECT {r4("avg(CASE WHEN modal_price >= least(p_last, p_mean) AND modal_price <= greatest(p_last, p_mean) THEN 1.0 ELSE 0.0 END) * 100")} AS interval_coverage_10_90_pct,
       {r4("avg(greatest(p_last, p_mean) - least(p_last, p_mean))")} AS avg_interval_width
FROM fc WHERE p_last IS NOT NULL AND p_mean IS NOT NULL"""))
def q_interval(spark, sf_dir):
    """A9 for the crossing lag/mean band (reordered before scoring)."""
    fc = _forecasts(tb.price_obs(spark, sf_dir)).where(F.col("p_last").isNotNull()
                                                       & F.col("p_mean").isNotNull())
    return finish(metrics.interval_quality(fc, "modal_price", "p_last", "p_mean"))


@register("quantile_scorecard", with_fixtures(_FC, """b AS (
  SELECT commodity, modal_price AS y, least(p_last, p_mean) AS lo, greatest(p_last, p_mean) AS hi,
         (p_last + p_mean) / 2 AS med
  FROM fc WHERE modal_price IS NOT NULL AND p_last IS NOT NULL AND p_mean IS NOT NULL)""", select=f"""
SELECT commodity,
       {r4("sqrt(avg((y - med) * (y - med)))")} AS test_rmse_median,
       {r4("avg(abs(y - med))")} AS test_mae_median,
       {r4("avg(abs((y - med) / (CASE WHEN abs(y) < 1e-9 THEN 1.0 ELSE abs(y) END))) * 100")} AS test_mape_median,
       {r4("CASE WHEN var_pop(y) * count(*) = 0 THEN (CASE WHEN sum((y - med) * (y - med)) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - sum((y - med) * (y - med)) / (var_pop(y) * count(*)) END")} AS test_r2_median,
       {r4("avg(greatest(0.1 * (y - lo), (0.1 - 1) * (y - lo)))")} AS pinball_q10,
       {r4("avg(greatest(0.5 * (y - med), (0.5 - 1) * (y - med)))")} AS pinball_q50,
       {r4("avg(greatest(0.9 * (y - hi), (0.9 - 1) * (y - hi)))")} AS pinball_q90,
       {r4("avg(CASE WHEN y >= lo AND y <= hi THEN 1.0 ELSE 0.0 END) * 100")} AS interval_coverage_10_90_pct,
       {r4("avg(hi - lo)")} AS avg_interval_width
FROM b GROUP BY commodity"""))
def q_scorecard(spark, sf_dir):
    """A10: the quantile scorecard of the lag/mean band, per commodity."""
    fc = _forecasts(tb.price_obs(spark, sf_dir))
    fc = fc.withColumn("p50", (F.col("p_last") + F.col("p_mean")) / 2)
    return finish(metrics.quantile_scorecard(fc, "modal_price", "p_last", "p50", "p_mean",
                                             by=["commodity"]))


@register("prediction_coverage", with_fixtures(_FC, select=f"""
SELECT {r4("avg(CASE WHEN p_mean IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100")} AS coverage_pct FROM fc"""))
def q_pred_cov(spark, sf_dir):
    """Share of rows with a rolling-mean prediction."""
    from pricecast.operators.meta import coverage_pct
    return finish(coverage_pct(_forecasts(tb.price_obs(spark, sf_dir)), "p_mean"))


@register("macro_average", with_fixtures(_FC, f"""per AS (
  SELECT commodity, state, district, market, {_metric_sql("modal_price", "p_last")}
  FROM fc WHERE modal_price IS NOT NULL AND p_last IS NOT NULL
  GROUP BY commodity, state, district, market)""", select=f"""
SELECT commodity, {r4(_exact_mean_sql("rmse"))} AS rmse, {r4(_exact_mean_sql("mae"))} AS mae,
       {r4(_exact_mean_sql("mape"))} AS mape, {r4(_exact_mean_sql("r2"))} AS r2,
       count(*) AS n_series
FROM (SELECT commodity, rmse, mae, mape, r2 FROM per) GROUP BY commodity"""))
def q_macro(spark, sf_dir):
    """Macro average over per-series metrics of the persistence forecast.
    Per-series metrics are rounded as stored (4 dp) before averaging."""
    fc = _forecasts(tb.price_obs(spark, sf_dir))
    per = finish(metrics.regression_metrics(fc, "modal_price", "p_last", by=tb.SERIES_KEY))
    return finish(metrics.macro_average(per, ["rmse", "mae", "mape", "r2"], by=["commodity"]))


@register("model_comparison", with_fixtures(_SPLIT_CTE, _FC.replace("FROM price_obs)", """FROM price_obs),
t AS (SELECT fc.* FROM fc JOIN splitted s ON fc.market = s.market AND fc.arrival_date = s.arrival_date
      AND fc.k1 = s.k1 AND fc.k2 = s.k2 AND fc.k3 = s.k3 WHERE s.split = 'test')"""), select=f"""
SELECT * FROM (
  SELECT 'persistence' AS model, {_metric_sql("modal_price", "p_last")}, count(*) AS n FROM t
  WHERE modal_price IS NOT NULL AND p_last IS NOT NULL
  UNION ALL
  SELECT 'weekly_naive', {_metric_sql("modal_price", "p_week")}, count(*) FROM t
  WHERE modal_price IS NOT NULL AND p_week IS NOT NULL
  UNION ALL
  SELECT 'rolling_mean_7', {_metric_sql("modal_price", "p_mean")}, count(*) FROM t
  WHERE modal_price IS NOT NULL AND p_mean IS NOT NULL)"""))
def q_compare(spark, sf_dir):
    """M9 + U2: test-split metrics of three forecasts, stacked, ascending RMSE."""
    fc = _forecasts(split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER))
    rows = metrics.metrics_of_models(fc.where(F.col("split") == "test"), "modal_price",
                                     {"persistence": "p_last", "weekly_naive": "p_week", "rolling_mean_7": "p_mean"})
    return finish(metrics.compare_models(rows))


@register("pick_test_row", with_fixtures(_SPLIT_CTE, select=f"""
SELECT commodity, {ID_SQL}, split FROM (
  SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY (upper(split) = 'TEST') DESC,
         arrival_date DESC, k1 DESC, k2 DESC, k3 DESC, market DESC) AS rn
  FROM splitted) WHERE rn = 1"""))
def q_pick_test(spark, sf_dir):
    """Per commodity the (latest) TEST-labelled row, else the last row."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    sp = sp.withColumn("_position", F.struct(*SPLIT_ORDER)).select(
        "commodity", *ID, "split", "_position")
    out = split.pick_test_row(sp, ["commodity"], position_col="_position")
    return finish(out.select("commodity", *ID, "split"))


@register("history_union", with_fixtures(_SPLIT_CTE, select=f"""
SELECT {ID_SQL}, split, CASE WHEN split = 'train' THEN variety END AS variety, {r4("modal_price")} AS modal_price
FROM splitted WHERE split IN ('train', 'val')"""))
def q_union(spark, sf_dir):
    """Train + val concatenated by name into the history frame; the val part lacks a column."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    train = sp.where(F.col("split") == "train")
    val = sp.where(F.col("split") == "val").drop("variety")
    return finish(split.union_splits(train, val).select(*ID, "split", "variety", "modal_price"))


@register("sample_rows", with_fixtures(select=f"""
SELECT commodity, state, {ID_SQL}, {r4("modal_price")} AS modal_price FROM price_obs
ORDER BY md5(concat_ws('|', {", ".join(f"CAST({c} AS VARCHAR)" for c in ID)}, '42')), {", ".join(ID)} LIMIT 500"""))
def q_sample(spark, sf_dir):
    """Repeatable seeded sample of at most 500 observations."""
    got = split.sample_n(tb.price_obs(spark, sf_dir), 500, seed=42, key=ID)
    return finish(got.select("commodity", "state", *ID, "modal_price"))


_ONEHOT_SQL = with_fixtures(f"""feats AS (
  SELECT DISTINCT 'state_' || state AS feature, 's' AS kind FROM price_obs WHERE state IS NOT NULL
  UNION SELECT DISTINCT 'market_' || market, 'm' FROM price_obs WHERE market IS NOT NULL
  UNION SELECT DISTINCT 'Commodity_' || commodity, 'c' FROM price_obs WHERE commodity IS NOT NULL)""",
                            select=f"""
SELECT r.request_id, f.feature FROM requests r JOIN feats f ON
  (f.kind = 's' AND {norm_sql("coalesce(r.state, '')")} <> ''
   AND {norm_sql("'state_' || " + norm_sql("coalesce(r.state, '')"))} = {norm_sql("f.feature")})
  OR (f.kind = 'm' AND {norm_sql("coalesce(r.market, '')")} <> ''
   AND {norm_sql("'market_' || " + norm_sql("coalesce(r.market, '')"))} = {norm_sql("f.feature")})
  OR (f.kind = 'c' AND {norm_sql("coalesce(r.commodity, '')")} <> ''
   AND {norm_sql("'commodity_' || " + norm_sql("coalesce(r.commodity, '')"))} = {norm_sql("f.feature")})""")


@register("one_hot_requests", _ONEHOT_SQL)
def q_onehot(spark, sf_dir):
    """The one-hot features (named after the history's states, markets and
    commodities) that each request switches on, long: (request_id, feature)."""
    obs = tb.price_obs(spark, sf_dir)
    names = None
    for field, prefix in (("state", "state_"), ("market", "market_"), ("commodity", "Commodity_")):
        part = obs.select(F.concat(F.lit(prefix), field).alias("feature")).distinct()
        names = part if names is None else names.unionByName(part)
    return encode.one_hot_hits(tb.requests(spark, sf_dir), names, ["request_id"])


@register("top_impacts", with_fixtures(_SPLIT_CTE, """st AS (
  SELECT avg(modal_price) AS m1, stddev_pop(modal_price) AS s1, avg(arrival_quantity) AS m2,
         stddev_pop(arrival_quantity) AS s2, avg(min_price) AS m3, stddev_pop(min_price) AS s3
  FROM splitted WHERE split = 'train'),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity, state, district, market
           ORDER BY arrival_date DESC, k1 DESC, k2 DESC, k3 DESC) AS rn FROM price_obs) WHERE rn = 1),
z AS (SELECT commodity, state, district, market,
             (modal_price - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END AS modal_price,
             (arrival_quantity - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END AS arrival_quantity,
             (min_price - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END AS min_price FROM latest, st),
long AS (SELECT commodity, state, district, market, 'modal_price' AS feature, modal_price AS impact FROM z
         UNION ALL SELECT commodity, state, district, market, 'arrival_quantity', arrival_quantity FROM z
         UNION ALL SELECT commodity, state, district, market, 'min_price', min_price FROM z),
ranked AS (SELECT *, row_number() OVER (PARTITION BY commodity, state, district, market
                                        ORDER BY abs(impact) DESC, feature) AS rank FROM long)""",
                                      select=f"""
SELECT commodity, state, district, market, feature, {r4("impact")} AS impact, rank,
       {r4("abs(impact) / greatest(max(abs(impact)) OVER (PARTITION BY commodity, state, district, market), 1.0) * 100")} AS width_pct
FROM ranked WHERE rank <= 2"""))
def q_top_impacts(spark, sf_dir):
    """Top-2 standardized feature impacts of each series' latest row."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    cols = ["modal_price", "arrival_quantity", "min_price"]
    stats = encode.fit_scaler(sp.where(F.col("split") == "train"), cols)
    latest = latest_per_key(tb.price_obs(spark, sf_dir).select(*tb.SERIES_KEY, *ORDER, *cols),
                            tb.SERIES_KEY, ORDER)
    z = encode.apply_scaler(latest, stats, cols)
    out = features.top_impacts(z, tb.SERIES_KEY, cols, k=2)
    return finish(out.select(*tb.SERIES_KEY, "feature", "impact", "rank", "width_pct"))
