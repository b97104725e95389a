"""Registered model jobs (rows-only checks: model outputs have no SQL oracle).

Every job trains on the whole training split of the fixture tables; the
numbers of trees and trials are parameters, set below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricecast.models import arima, attribution, gbt, hist_trees, quantile_gbm, sequence_models, stacking, tree_paths
from pricecast.models.common import CAT_COLS, NUM_COLS, ROW_KEY, TARGET, model_frame, request_codes
from pricecast.operators import metrics, split
from pricecast.operators.lookup import asof_fallback
from pricecast.operators.schema import align_features
from pricecast.plans.catalog import finish, register
from pricecast.plans.forecast import BandForecaster, confidence, forecast_output
from pricecast.plans.eval_queries import _FC, _forecasts
from pricecast.plans.feature_queries import _SPLIT_CTE, FEATURES_CTES, ID_SQL
from pricecast.plans.oracle import norm_sql, r4, with_fixtures
from pricecast.plans.serve_queries import _FLAGSHIP_SQL, CANDIDATES_CTE, REQ_CTE
from pricecast.session import checkpoint, ensure_checkpoint_dir, together
from pricecast.sources import tables as tb

SEQ_KEY = ["commodity", "state", "market"]
ORDER = ["arrival_date", "k1", "k2", "k3"]
SPLIT_ORDER = ["arrival_date", "k1", "k2", "k3", "market"]

# Work of the registered jobs but stacking_meta_metrics, below the functions' defaults (1500 stages and 1200
TREES, STAGES, STEP = 40, 70, 0.1


@register("gbt_metrics")
def q_gbt(spark, sf_dir):
    """M2: boosted trees (coded categories + numerics), val/test metrics."""
    frame, feats = model_frame(spark, sf_dir)
    m, _ = gbt.gbt_metrics(frame, feats, stages=TREES, step=STEP)
    return finish(m)


@register("quantile_gbm_scorecard")
def q_quantile_gbm(spark, sf_dir):
    """M1 + A10: q10/q50/q90 boosters with leaf quantile refits, test scorecard."""
    frame, feats = model_frame(spark, sf_dir)
    model = quantile_gbm.fit_quantiles(frame.where(F.col("split") == "train"), feats, stages=STAGES, step=STEP)
    pred = quantile_gbm.predict_interval(model, frame.where(F.col("split") == "test"))
    return finish(metrics.quantile_scorecard(pred))


@register("arima_series_metrics")
def q_arima(spark, sf_dir):
    """M5: per-series ARIMA order search (top-2 markets per commodity)."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    return finish(arima.arima_search(sp))


@register("sequence_model_metrics")
def q_seq(spark, sf_dir):
    """M6 + W10-W12: 30-row window model on the log-delta target."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    return finish(sequence_models.sequence_metrics(sp, SEQ_KEY, ORDER))


@register("sequence_recurrent_metrics")
def q_seq_recurrent(spark, sf_dir):
    """M6 with a recurrent state next to the 30-row window, on the log-delta target."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    return finish(sequence_models.recurrent_metrics(sp, SEQ_KEY, ORDER))


@register("sequence_level_metrics")
def q_seq_level(spark, sf_dir):
    """M6, level target + W10 whole-table scope: 30-row windows in date order."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    return finish(sequence_models.level_metrics(sp, SPLIT_ORDER))


@register("per_commodity_sequence_metrics")
def q_seq_commodity(spark, sf_dir):
    """M7: one window model per commodity with at least 2000 training rows."""
    sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
    return finish(sequence_models.per_commodity_metrics(sp, SEQ_KEY, ORDER))


@register("attribution_summary")
def q_attr(spark, sf_dir):
    """M8 + W14: permutation attribution of the boosted-tree model on seeded
    samples (1000 explained test rows, 500 background rows)."""
    frame, feats = model_frame(spark, sf_dir)
    model = gbt.fit_gbt(frame.where(F.col("split") == "train"), feats, max_iter=TREES, step=STEP)
    contrib = attribution.explain_sample(model, frame, feats, ROW_KEY)
    return finish(attribution.attribution_summary(contrib))


@register("attribution_paths")
def q_attr_paths(spark, sf_dir):
    """M8 without sampling: path-based Shapley values of every test row on the boosted trees, with all
    training rows as background; per feature its mean impacts, and the largest gap between a row's
    values and its prediction less the base."""
    frame, feats = model_frame(spark, sf_dir)
    train = frame.where(F.col("split") == "train")
    model = gbt.fit_model(train, feats, stages=TREES, step=STEP)
    got = checkpoint(tree_paths.path_attribution(model, frame.where(F.col("split") == "test"), train, ROW_KEY))
    gap = F.abs(F.aggregate(F.map_values("impacts"), F.col("base"), lambda a, v: a + v) - F.col("prediction"))
    largest = got.agg(F.max(gap)).first()[0]
    return finish(tree_paths.feature_impacts(got).withColumn("largest_gap", F.lit(largest).cast("double")))


@register("stacking_meta_metrics")
def q_stack(spark, sf_dir):
    """M3 + M4 + M9: tree and window predictions joined by row key into the
    stacking set; seeded meta-model search; test metrics of all three models
    compared by RMSE, all at the reference's settings: 1200 trees at step 0.03, 30
    trials of 300 to 2000 trees, none stopped early. The two base models do not
    need each other, so their jobs run side by side."""
    def trees():
        frame, feats = model_frame(spark, sf_dir)
        model = gbt.fit_model(frame.where(F.col("split") == "train"), feats)
        rest = frame.where(F.col("split") != "train")
        return rest, hist_trees.score(model, rest.select(*ROW_KEY, *feats)).select(*ROW_KEY, F.col("pred").alias("gbt_pred"))

    def windows():
        sp = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)
        sframe = sequence_models.sequence_frame(sp, SEQ_KEY, ORDER)
        smodel = sequence_models.fit_sequence_model(sframe.where(F.col("split") == "train"))
        return (sequence_models.score(smodel, sframe.where(F.col("split") != "train"))
                .select(*ROW_KEY, F.col("pred_price").alias("seq_pred")))

    (rest, gpred), spred = together(spark, trees, windows)
    st = stacking.stacking_set(rest, gpred, spred, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    mfeats = ["gbt_pred", "seq_pred", "has_seq",
              *[c for c in stacking.CONTEXT if c in st.columns]]
    meta_val, meta_test = st.where(F.col("split") == "val"), st.where(F.col("split") == "test")
    meta, _ = stacking.meta_search(meta_val, meta_test, mfeats)
    base = [metrics.regression_metrics(meta_test, TARGET, p).select(
        F.lit(n).alias("model"), F.lit("test").alias("split"), "*")
        for n, p in (("gbt", "gbt_pred"), ("seq_linear", "seq_pred"))]
    return finish(metrics.compare_models(metrics.stack_metrics(meta, *base)))


_STACK_CTE = _SPLIT_CTE.replace("FROM price_obs WHERE", "FROM fc WHERE")


@register("stacking_set_rows", with_fixtures(_FC, _STACK_CTE, select=f"""
SELECT {ID_SQL}, split, {r4("modal_price")} AS modal_price, {r4("g")} AS gbt_pred, {r4("coalesce(s, g)")} AS seq_pred,
  CASE WHEN s IS NULL THEN 0 ELSE 1 END AS has_seq, {r4("coalesce(arrival_quantity, 0)")} AS arrival_quantity
FROM (SELECT *, CASE WHEN k1 % 5 <> 0 THEN p_mean END AS g, CASE WHEN k2 % 2 = 1 THEN p_last END AS s FROM splitted) WHERE split <> 'train'"""))
def q_stack_rows(spark, sf_dir):
    """M3 + J4 + F9: given predictions of two models (the rolling mean without some rows, the last
    price of every other line) joined by row key over tables stored by it, the second filled from the first."""
    obs = checkpoint(_forecasts(split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER)).where(F.col("split") != "train"))
    gpred = obs.where(F.col("k1") % 5 != 0).select(*ROW_KEY, F.col("p_mean").alias("gbt_pred"))
    spred = obs.where(F.col("k2") % 2 == 1).select(*ROW_KEY, F.col("p_last").alias("seq_pred"))
    base = obs.select(*ROW_KEY, "split", TARGET, "arrival_quantity")
    st = stacking.stacking_set(base, gpred, spred, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return finish(st.select(*ROW_KEY, "split", TARGET, "gbt_pred", "seq_pred", "has_seq", "arrival_quantity"))


@register("inner_split_rows", with_fixtures(_SPLIT_CTE, select=f"""
SELECT {ID_SQL}, CASE WHEN row_number() OVER (ORDER BY arrival_date, k1, k2, k3, market) - 1 < floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
  THEN 'fit' ELSE 'hold' END AS inner_split FROM splitted WHERE split = 'val'"""))
def q_inner(spark, sf_dir):
    """The search's 80/20 split by time of the validation rows."""
    val = split.time_split(tb.price_obs(spark, sf_dir), SPLIT_ORDER).where(F.col("split") == "val")
    return finish(stacking.inner_split(val).select(*ROW_KEY, F.col("_inner").alias("inner_split")))


@register("reload_scores", with_fixtures(FEATURES_CTES, """pos AS (
  SELECT *, row_number() OVER (ORDER BY arrival_date, k1, k2, k3, market) - 1 AS p, count(*) OVER () AS n
  FROM f WHERE modal_lag_7 IS NOT NULL AND arrival_date IS NOT NULL),
s AS (SELECT CASE WHEN p < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN p < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
  ELSE 'test' END AS split FROM pos)""", select="""
SELECT split, count(*) AS n, count(*) AS n_equal, count(*) AS n_scored FROM s WHERE split <> 'train' GROUP BY split"""))
def q_reload(spark, sf_dir):
    """Models and feature list saved, loaded and scored again: every val and test row gets the same
    interval as before, to the bit, and the model's ordered features and settings come back."""
    frame, feats = model_frame(spark, sf_dir)
    model = quantile_gbm.fit_quantiles(frame.where(F.col("split") == "train"), feats, stages=3, step=STEP)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    hist_trees.save(model, path, spark)
    again = hist_trees.load(path, spark)
    if again.feats != feats or again.specs != model.specs:
        raise ValueError("the loaded model has other features or settings")
    rest = frame.where(F.col("split") != "train")
    both = hist_trees.score(again, quantile_gbm.predict_interval(model, rest).withColumnsRenamed({c: f"_{c}" for c in quantile_gbm.NAMES}))
    same = F.col("p10").eqNullSafe(F.col("_p10")) & F.col("p50").eqNullSafe(F.col("_p50")) & F.col("p90").eqNullSafe(F.col("_p90"))
    known = F.col("p10").isNotNull() & F.col("p90").isNotNull()
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(same.cast("long")).alias("n_equal"), F.sum(known.cast("long")).alias("n_scored"))


_DATE_FEATS = ("month", "day_of_week", "weekofyear", "month_sin", "month_cos", "dow_sin", "dow_cos")
_ECHO = ["request_id", "state", "market", "commodity", "arrival_date", "fallback_level"]


def _request_vectors(spark, sf_dir, frame, feats):
    """Requests -> J2 on the engineered training rows -> P8 align, date features and
    category codes of the request itself."""
    train = frame.where(F.col("split") == "train")
    payload = [c for c in feats if c not in _DATE_FEATS]
    hist = train.select("state", "market", "commodity", "arrival_date", "k1", "k2", "k3",
                        *payload)
    # market completes the tie-break where series of several markets are matched as one
    matched = asof_fallback(tb.requests(spark, sf_dir), hist, payload, ["k1", "k2", "k3", "market"])
    keys = ["key_state", "key_market", "key_commodity"]
    x = align_features(matched, feats, keep=[*_ECHO, *keys])
    # only rows without any match (date_only) have no features at all; those are zero
    unmatched = F.col("fallback_level") == "date_only"
    x = x.withColumns({c: F.when(unmatched, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c in feats})
    return request_codes(x, train, ["state", "market", "commodity"]).drop(*keys)


_VECTOR_NUM = [c for c in NUM_COLS if c not in _DATE_FEATS]


def _codes(col: str) -> str:
    return f"""code_{col} AS (
  SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx
  FROM (SELECT DISTINCT coalesce(CAST({col} AS VARCHAR), 'nan') AS value FROM train)),
asked_{col} AS (SELECT {norm_sql("value")} AS name, min(idx) AS idx FROM code_{col} GROUP BY 1)"""


_VECTOR_SQL = with_fixtures(FEATURES_CTES, """pos AS (
  SELECT *, row_number() OVER (ORDER BY arrival_date, k1, k2, k3, market) - 1 AS p, count(*) OVER () AS n
  FROM f WHERE modal_lag_7 IS NOT NULL AND arrival_date IS NOT NULL),
train AS (SELECT *, row_number() OVER () AS rid FROM pos WHERE p < floor(n * CAST(0.7 AS DOUBLE)))""",
                            *[_codes(c) for c in CAT_COLS], f"""hist AS (
  SELECT {norm_sql("coalesce(CAST(state AS VARCHAR), 'nan')")} AS s,
         {norm_sql("coalesce(CAST(market AS VARCHAR), 'nan')")} AS m,
         {norm_sql("coalesce(CAST(commodity AS VARCHAR), 'nan')")} AS c,
         arrival_date AS d, k1, k2, k3, rid, NULL AS min_price, NULL AS max_price, NULL AS arrival_quantity
  FROM train)""", REQ_CTE, CANDIDATES_CTE, f"""picked AS (
  SELECT r.*, coalesce(b.name, 'date_only') AS fallback_level, b.rid
  FROM req r LEFT JOIN best b ON b.request_id = r.request_id)""", select=f"""
SELECT r.request_id, r.state, r.market, r.commodity, r.arrival_date, r.fallback_level,
       CAST(month(r.arrival_date) AS BIGINT) AS month, CAST(weekofyear(r.arrival_date) AS BIGINT) AS weekofyear,
       CAST(isodow(r.arrival_date) - 1 AS BIGINT) AS day_of_week,
       {r4("sin(2 * pi() * month(r.arrival_date) / 12)")} AS month_sin,
       {r4("cos(2 * pi() * month(r.arrival_date) / 12)")} AS month_cos,
       {r4("sin(2 * pi() * (isodow(r.arrival_date) - 1) / 7)")} AS dow_sin,
       {r4("cos(2 * pi() * (isodow(r.arrival_date) - 1) / 7)")} AS dow_cos,
       {", ".join(f"{r4(f'coalesce(t.{c}, 0)')} AS {c}" for c in _VECTOR_NUM)},
       {", ".join(f"coalesce({f'q_{c}.idx, ' if c in ('state', 'market', 'commodity') else ''}x_{c}.idx, 0) AS {c}_idx"
                  for c in CAT_COLS)}
FROM picked r LEFT JOIN train t ON t.rid = r.rid
{" ".join(f"LEFT JOIN code_{c} x_{c} ON t.rid IS NOT NULL AND x_{c}.value = coalesce(CAST(t.{c} AS VARCHAR), 'nan')"
          for c in CAT_COLS)}
{" ".join(f"LEFT JOIN asked_{c} q_{c} ON q_{c}.name <> '' AND q_{c}.name = r.key_{c}"
          for c in ('state', 'market', 'commodity'))}""")


@register("request_feature_vectors", _VECTOR_SQL)
def q_vectors(spark, sf_dir):
    """M10 before scoring: the model input of every request."""
    frame, feats = model_frame(spark, sf_dir)
    x = _request_vectors(spark, sf_dir, frame, feats)
    whole = ["month", "weekofyear", "day_of_week", *[f"{c}_idx" for c in CAT_COLS]]
    return finish(x.withColumns({**{c: F.col(c).cast("bigint") for c in whole},
                                 **{c: F.col(c).cast("double") for c in feats if c not in whole}}))


@register("forecast_requests_model")
def q_m10(spark, sf_dir):
    """Request vectors -> quantile boosters -> P9 + P10, echoing the request."""
    frame, feats = model_frame(spark, sf_dir)
    model = quantile_gbm.fit_quantiles(frame.where(F.col("split") == "train"), feats, stages=STAGES, step=STEP)
    x = _request_vectors(spark, sf_dir, frame, feats)
    pred = quantile_gbm.predict_interval(model, x.withColumn(TARGET, F.lit(None).cast("double")))
    out = forecast_output(pred.withColumnsRenamed({"p10": "q10", "p50": "q50", "p90": "q90"}))
    return finish(out.select(*_ECHO, "q10", "q50", "q90", "interval_width",
                             confidence(F.col("fallback_level")).alias("confidence_pct")))


@register("stream_forecast_bands", "SELECT request_id, fallback_level, matched_date, q10, q50, q90, interval_width, "
          "confidence_pct FROM (" + _FLAGSHIP_SQL + ")")
def q_stream(spark, sf_dir):
    """ST1: the flagship scoring run as a file stream of request batches
    (4 files -> 4 micro-batches) against the history snapshot."""
    from pricecast.plans.serve_queries import PAYLOAD, SERVE_TIEBREAK
    from pricecast.streaming.requests_stream import score_request_stream
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    req = tb.requests(spark, sf_dir)
    req.repartition(4, "request_id").write.parquet(f"{base}/source")
    # history snapshot and bands prepared once, reused by every micro-batch
    model = BandForecaster(tb.price_obs(spark, sf_dir), SERVE_TIEBREAK, PAYLOAD)

    def score(batch):
        return model.score(batch).select(
            "request_id", "fallback_level", "matched_date", "q10", "q50", "q90",
            "interval_width", "confidence_pct")
    score_request_stream(spark, f"{base}/source", req.schema, f"{base}/sink", f"{base}/ckpt",
                         score)
    return finish(spark.read.parquet(f"{base}/sink").drop("epoch"))

