"""E1-E5 and A1/A2 on hand-written rows."""
from pyspark.sql import functions as F

from pricecast.operators import encode, meta


def test_category_index_unseen_null_unk(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,), ("__UNK__",)], "c string")
    test = spark.createDataFrame([("a",), ("zzz",), (None,), ("__UNK__",)], "c string")
    m = {r["value"]: r["idx"] for r in encode.fit_category_index(train, ["c"]).collect()}
    assert m == {"__UNK__": 0, "a": 1, "b": 2, "nan": 3}
    out = encode.apply_category_index(test, encode.fit_category_index(train, ["c"]), ["c", "gone"])
    got = sorted((r["c"], r["gone"]) for r in out.collect())
    assert got == [(-1, -1), (0, -1), (1, -1), (3, -1)]


def test_one_hot_by_column_name(spark):
    feats = ["state_Tamil Nadu", "market_nasik_apmc", "Commodity_Onion", "other"]
    req = spark.createDataFrame([(" tamil  nadu", "Nasik APMC", "onion"), ("", "x", "rice")],
                                "state string, market string, commodity string")
    out = encode.set_one_hot(schema_align(req, feats), feats).collect()
    assert [out[0][c] for c in feats] == [1, 1, 1, 0]
    assert [out[1][c] for c in feats] == [0, 0, 0, 0]


def schema_align(df, feats):
    from pricecast.operators.schema import align_features
    return align_features(df, feats, keep=["state", "market", "commodity"])


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    st = encode.fit_scaler(df, ["a", "b"])
    r = st.first()
    assert (r["a__mean"], r["a__std"], r["b__std"]) == (2.0, 1.0, 1.0)
    z = encode.apply_scaler(df, st, ["a", "b"]).orderBy("a").collect()
    assert [x["a"] for x in z] == [-1.0, 1.0] and [x["b"] for x in z] == [0.0, 0.0]


def test_top_markets_arrival_branches(spark):
    rows = [("S", "m1", "c", 10.0, None), ("S", "m1", "c", 20.0, None),
            ("S", "m2", "c", 30.0, 5.0), ("S", "m3", "c", None, 100.0)]
    df = spark.createDataFrame(rows, "state string, market string, commodity string, "
                                     "modal_price double, arrivals double")
    out = meta.top_markets(df, k=10).collect()
    assert [(r["market"], r["activity"], r["records"]) for r in out] == [("m2", 5.0, 1),
                                                                        ("m1", 0.0, 2)]
    allnull = df.withColumn("arrivals", F.lit(None).cast("double"))
    out2 = meta.top_markets(allnull, k=1).collect()
    assert [(r["market"], r["activity"], r["avg_price"]) for r in out2] == [("m1", 2.0, 15.0)]


def test_top_markets_plan_pushes_filter(spark, tmp_path):
    p = str(tmp_path / "obs")
    spark.createDataFrame([("S", "m", "c", 1.0, 1.0)], "state string, market string, "
                          "commodity string, modal_price double, arrivals double"
                          ).write.parquet(p)
    plan = meta.top_markets(spark.read.parquet(p), state="S", k=3)._jdf.queryExecution()\
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(state), EqualTo(state,S)" in plan or "EqualTo(state,S)" in plan
    assert "TakeOrderedAndProject" in plan
