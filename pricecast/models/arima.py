"""M5: per-series ARIMA order search, parallel over series.

Series = (commodity, market) for each commodity's top-2 markets with at
least 40 training rows (A5 + F7). Each series is first reduced to one value
per day (partial-aggregated mean), so the group one Python worker receives
is bounded by the calendar, never by the row count of a hot series. Inside
the group (numpy only): conditional least squares for every order
p in 0..2, d in 0..1, q in 0..2 (Hannan-Rissanen: a long AR gives residual
estimates, then y_t is regressed on its lags and lagged residuals), AIC on
a sample common to all orders, recursive forecast of the validation
horizon, refit on train+val, forecast of the test horizon, metrics.
A series with no feasible order yields null metrics instead of failing.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricecast.operators.clean import min_group_rows
from pricecast.operators.meta import top_markets_per_commodity

ORDERS = list(itertools.product(range(3), range(2), range(3)))
LONG_AR = 8
METRIC_COLS = ["rmse", "mae", "mape", "r2"]
OUT_SCHEMA = ("commodity string, market string, p int, d int, q int, aic double, n_train long, "
              + ", ".join(f"{s}_{m} double" for s in ("val", "test") for m in METRIC_COLS))


def _lags(x: np.ndarray, k: int, start: int) -> np.ndarray:
    return np.column_stack([x[start - i:len(x) - i] for i in range(1, k + 1)]) if k else \
        np.empty((len(x) - start, 0))


def _fit(z: np.ndarray, p: int, q: int, start: int):
    """CSS fit of ARMA(p, q) with intercept on ``z`` from index ``start``."""
    e = np.zeros_like(z)
    if q:
        X = np.column_stack([np.ones(len(z) - LONG_AR), _lags(z, LONG_AR, LONG_AR)])
        b = np.linalg.lstsq(X, z[LONG_AR:], rcond=None)[0]
        e[LONG_AR:] = z[LONG_AR:] - X @ b
    X = np.column_stack([np.ones(len(z) - start), _lags(z, p, start), _lags(e, q, start)])
    coef = np.linalg.lstsq(X + 0.0, z[start:], rcond=None)[0]
    resid = z[start:] - X @ coef
    return coef, resid, e


def _forecast(z: np.ndarray, e: np.ndarray, coef: np.ndarray, p: int, q: int, h: int):
    zs, es = list(z), list(e)
    out = []
    for _ in range(h):
        v = coef[0] + sum(coef[1 + i] * zs[-1 - i] for i in range(p)) \
            + sum(coef[1 + p + j] * es[-1 - j] for j in range(q))
        zs.append(v)
        es.append(0.0)
        out.append(v)
    return np.array(out)


def _predict(y: np.ndarray, p: int, d: int, q: int, h: int):
    z = np.diff(y) if d else y
    start = max(p, q, LONG_AR if q else 0)
    if len(z) - start <= p + q + 2:
        return None, None
    coef, resid, e = _fit(z, p, q, start)
    fz = _forecast(z, e, coef, p, q, h)
    fc = y[-1] + np.cumsum(fz) if d else fz
    return fc, resid


def _metrics(y: np.ndarray, p: np.ndarray) -> list[float | None]:
    if p is None or len(y) == 0:
        return [None] * 4
    err = y - p
    den = np.where(np.abs(y) < 1e-9, 1.0, np.abs(y))
    sse, sst = float(np.sum(err ** 2)), float(np.sum((y - y.mean()) ** 2))
    r2 = (1.0 if sse == 0 else 0.0) if sst == 0 else 1 - sse / sst
    return [float(np.sqrt(np.mean(err ** 2))), float(np.mean(np.abs(err))),
            float(np.mean(np.abs(err / den)) * 100), float(r2)]


def fit_series(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("arrival_date")
    tr = pdf.loc[pdf["split"] == "train", "y"].to_numpy(float)
    va = pdf.loc[pdf["split"] == "val", "y"].to_numpy(float)
    te = pdf.loc[pdf["split"] == "test", "y"].to_numpy(float)
    common = 1 + max(2, LONG_AR)          # same sample for every order's AIC
    best = None
    for p, d, q in ORDERS:
        z = np.diff(tr) if d else tr
        if len(z) - common <= p + q + 2:
            continue
        coef, resid, _ = _fit(z, p, q, max(p, q, LONG_AR if q else 0))
        r = resid[-(len(z) - common):]
        sse = float(np.sum(r ** 2))
        if not np.isfinite(sse) or sse <= 0:
            continue
        aic = len(r) * np.log(sse / len(r)) + 2 * (p + q + 1)
        if best is None or aic < best[0]:
            best = (aic, p, d, q)
    row = {"commodity": pdf["commodity"].iat[0], "market": pdf["market"].iat[0],
           "n_train": len(tr)}
    if best is None:
        row.update(p=None, d=None, q=None, aic=None)
        vm = tm = [None] * 4
    else:
        aic, p, d, q = best
        row.update(p=p, d=d, q=q, aic=float(aic))
        fv, _ = _predict(tr, p, d, q, len(va))
        vm = _metrics(va, fv)
        ft, _ = _predict(np.concatenate([tr, va]), p, d, q, len(te))
        tm = _metrics(te, ft)
    for s, m in (("val", vm), ("test", tm)):
        for name, v in zip(METRIC_COLS, m):
            row[f"{s}_{name}"] = v
    return pd.DataFrame([row])


def arima_search(split_obs: DataFrame, min_train_rows: int = 40, top_n: int = 2) -> DataFrame:
    """Per-series metrics table (one row per selected series)."""
    train = split_obs.where(F.col("split") == "train")
    top = top_markets_per_commodity(train, top_n).select("commodity", "market")
    sel = split_obs.join(top, ["commodity", "market"], "left_semi")
    sel = min_group_rows(sel.where(F.col("split") == "train"), ["commodity", "market"],
                         min_train_rows).select("commodity", "market").distinct()
    series = split_obs.join(sel, ["commodity", "market"], "left_semi")
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    daily = (series.groupBy("commodity", "market", "arrival_date")
                   .agg(F.avg("modal_price").alias("y"), F.min(rank).alias("_s"))
                   .withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"),
                                                             F.lit("test")), F.col("_s") + 1))
                   .drop("_s"))
    return daily.groupBy("commodity", "market").applyInPandas(fit_series, OUT_SCHEMA)
