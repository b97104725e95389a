"""Properties of the model jobs and stream = batch for ST1."""
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pricecast.models import arima
from pricecast.models.attribution import drawn_pairs, permutation_attribution
from pricecast.models.common import assemble
from pricecast.operators.sequence import sequences
from pricecast.plans.forecast import BandForecaster, forecast_bands
from pricecast.plans.serve_queries import PAYLOAD, SERVE_TIEBREAK
from pricecast.session import ensure_checkpoint_dir
from pricecast.sources import tables as tb
from pricecast.streaming.requests_stream import score_request_stream
from tests.conftest import SF001, rows


def test_stream_equals_batch(spark):
    req = tb.requests(spark, SF001)
    hist = tb.price_obs(spark, SF001)
    cols = ["request_id", "fallback_level", "matched_date", "q10", "q50", "q90"]

    model = BandForecaster(hist, SERVE_TIEBREAK, PAYLOAD)

    def score(b):
        return model.score(b).select(*cols)
    base = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    req.repartition(3, "request_id").write.parquet(f"{base}/src")
    score_request_stream(spark, f"{base}/src", req.schema, f"{base}/sink", f"{base}/ck", score)
    streamed = spark.read.parquet(f"{base}/sink").select(*cols)
    assert rows(streamed) == rows(score(req))
    assert rows(streamed) == rows(forecast_bands(req, hist, SERVE_TIEBREAK, PAYLOAD).select(*cols))


def test_attribution_is_additive(spark):
    rnd = np.random.default_rng(0)
    pdf = pd.DataFrame(rnd.normal(size=(60, 3)), columns=["a", "b", "c"])
    pdf["y"] = 2 * pdf.a - pdf.b + 0.5 * pdf.c
    pdf["id"] = range(60)
    df = spark.createDataFrame(pdf)
    feats = ["a", "b", "c"]
    model = LinearRegression(featuresCol="features", labelCol="y").fit(assemble(df, feats))
    x, bg = df.where("id < 5"), df.where("id >= 5")
    contrib = permutation_attribution(model, x, bg, feats, ["id"], n_perm=3)
    total = contrib.groupBy("id").agg(F.sum("impact").alias("s"))
    fx = model.transform(assemble(x, feats)).select("id", "prediction")
    drawn = drawn_pairs(x, bg, feats, ["id"], n_perm=3).select("id", *[F.col(f"_b_{c}").alias(c) for c in feats])
    assert drawn.join(bg.select(*feats), feats).count() == drawn.count() == 15   # real background rows
    base = {r["id"]: r["b"] for r in model.transform(assemble(drawn, feats))
            .groupBy("id").agg(F.avg("prediction").alias("b")).collect()}
    got = {r["id"]: r["s"] for r in total.collect()}
    for r in fx.collect():
        assert abs(got[r["id"]] - (r["prediction"] - base[r["id"]])) < 1e-6


def test_arima_short_and_regular_series():
    n = 120
    t = np.arange(n)
    y = 100 + 0.5 * t + np.sin(t / 3.0) * 5
    split = ["train"] * 84 + ["val"] * 18 + ["test"] * 18
    pdf = pd.DataFrame({"commodity": "c", "market": "m", "arrival_date": pd.date_range(
        "2020-01-01", periods=n), "y": y, "split": split})
    out = arima.fit_series(pdf).iloc[0]
    assert out["p"] is not None and out["test_rmse"] < 20
    short = arima.fit_series(pdf.iloc[:5]).iloc[0]
    assert short["aic"] is None and short["val_rmse"] is None


def test_sequences_short_series_and_empty(spark):
    data = [("s1", i, float(i)) for i in range(31)] + [("s2", i, float(i)) for i in range(30)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    seq = sequences(df, ["k"], ["t"], ["v"], "v", n=30)
    got = seq.collect()
    assert len(got) == 1 and got[0]["k"] == "s1" and got[0]["t"] == 30
    assert [x[0] for x in got[0]["seq"]] == [float(i) for i in range(30)]
    assert sequences(df.limit(0), ["k"], ["t"], ["v"], "v", n=30).count() == 0
